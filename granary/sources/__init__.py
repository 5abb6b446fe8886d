"""Tables that are synthesized, stored or read from files."""
