"""Graph algorithms: vertex programs and their closed forms."""
