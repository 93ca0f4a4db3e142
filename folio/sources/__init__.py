"""Sources and sinks: test-table views, run files, manifests, assets, prompts."""
