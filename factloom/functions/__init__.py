"""Part of the document fidelity engine."""
