"""DataFrame operators over security-event tables."""
