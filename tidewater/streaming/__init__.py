"""The order-dependent operators on streams of events."""
