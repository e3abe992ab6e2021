"""Part of codeloom: plans."""
