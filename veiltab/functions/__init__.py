"""Small driver-side functions: domains, privacy accounting, noise."""
