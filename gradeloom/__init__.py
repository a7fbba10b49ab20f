"""Batch jobs that evaluate the answers of language and audio-language models, as Spark DataFrame transformations."""
