"""Part of veilspark."""
