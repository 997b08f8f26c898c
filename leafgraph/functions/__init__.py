"""Part of the document-dependency engine."""
