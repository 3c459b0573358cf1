"""sparkloom: Spark-native preparation of language-model training text."""
