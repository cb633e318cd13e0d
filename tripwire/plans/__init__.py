"""Physical-plan helpers: checked broadcasts, skew-safe running sums, as-of joins."""
