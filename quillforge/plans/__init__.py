"""Driver-side plans and the catalogue of registered queries."""
