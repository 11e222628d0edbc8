"""See the package README for the operators that live here."""
