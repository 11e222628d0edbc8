"""``python -m matchloom NAME FOLDER [OUT]``: run a registered query over a folder of tables; without NAME their list."""

from __future__ import annotations

import sys


def main(arguments: list[str]) -> int:
    from matchloom.catalogue import QUERIES
    from matchloom.session import local_session
    from matchloom.sources.tables import write_table

    if len(arguments) < 2 or arguments[0] not in QUERIES:
        print("\n".join(sorted(QUERIES)))
        return 0 if not arguments else 2
    made = QUERIES[arguments[0]](local_session(), arguments[1])
    if len(arguments) > 2:
        print(write_table(made, arguments[2]))
    else:
        made.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
