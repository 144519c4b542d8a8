"""Operators for building training corpora: token files, fingerprints, privacy
and secret scans, near-duplicate removal, quality and toxicity scoring, HTML
extraction, mixing and benchmark decontamination. Nothing else in the library
imports this subpackage."""
