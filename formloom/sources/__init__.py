"""Part of formloom: sources."""
