"""From command text to Spark plans: tokens, expression trees, types and lowering."""
