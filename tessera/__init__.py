"""tessera -- Spark-native data-governance scans.

PII detection with context confidence, masking and encryption, data-quality
suites, industry rule packs, duplicate analysis, schema drift, health scores
and gold-layer trend analytics, all as DataFrame plans keyed by ``dataset``.
"""

from .profiles import CLI, FUNCTION, PROFILES, Profile, get_profile  # noqa: F401

__version__ = "0.1.0"
