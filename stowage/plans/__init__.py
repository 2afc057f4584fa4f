"""Action plans: one decision row per item of a request set."""
