"""End-to-end plans: conforming feeds, reports, quality profiles, comparisons."""
