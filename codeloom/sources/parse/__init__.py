"""Part of codeloom: sources/parse."""
