"""Part of formloom: streaming."""
