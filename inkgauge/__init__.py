"""inkgauge: Spark-native quality control and structuring of notice text."""
