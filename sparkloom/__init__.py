"""sparkloom: a Spark-first engine for governed text corpora and the decisions made over them."""
