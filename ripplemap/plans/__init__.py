"""Session settings, shared storage and the end-to-end review job."""
