"""Driver-side plans: the fixpoint and the staged, gated decisions."""
