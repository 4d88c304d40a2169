"""kelpline: a Spark-first analytics engine for noisy, short-token label text."""
