"""DataFrame operators over script documents."""
