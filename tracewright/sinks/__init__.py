"""Writers of reports and exchange files."""
