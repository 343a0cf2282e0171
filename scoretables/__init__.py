"""PySpark-native preparation of symbolic-sequence corpora and analysis of transcription results."""
