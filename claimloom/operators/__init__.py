"""operators of claimloom."""
