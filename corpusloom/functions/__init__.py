"""Column functions: text, captions, identifiers, licences, geometry."""
