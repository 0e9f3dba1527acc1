"""talkmill: Spark-first analytics over conversation data."""
