"""Where bars, instruments and feed messages come from."""
