"""Sources and sinks: texts, lexicons, the store of profiles."""
