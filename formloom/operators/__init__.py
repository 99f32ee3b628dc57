"""Part of formloom: operators."""
