"""DataFrame-to-DataFrame steps: matching, counting, labels, pages."""
