"""Privacy-risk analytics for micro-data tables, declared as DataFrame programs."""
