"""Production analytics for oil-field model cases, as plain DataFrame jobs."""
