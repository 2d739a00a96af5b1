"""DataFrame operators that scale past one task per key."""
