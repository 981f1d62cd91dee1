"""DataFrame operators over offers, observations and histories."""
