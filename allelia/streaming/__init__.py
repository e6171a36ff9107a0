"""Empty: the engine has bounded batch scans only. A scan writes each chromosome as it ends, so nothing here keeps state."""
