"""Jobs: sessions, configuration, workflow, metrics, retry, secrets and remote files."""
