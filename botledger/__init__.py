"""botledger: access-log analytics for crawler and AI-referral traffic on Spark."""

__version__ = "0.1.0"
