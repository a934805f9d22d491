"""Plans: end-to-end jobs (generate, ingest, script cleaning) and the
registered query catalog with its oracle SQL."""
