"""claimlens: claim-verification analytics expressed as Spark DataFrame operators."""
