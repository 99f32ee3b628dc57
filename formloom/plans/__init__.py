"""Part of formloom: plans."""
