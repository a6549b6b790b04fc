"""The library's result tables run over the TESTDATA star schema."""
