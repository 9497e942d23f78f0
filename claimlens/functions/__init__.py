"""Part of the claims-triage library; see the README for what lies where."""
