"""Clinical timelines on Spark: OMOP tables -> tokenized patient timelines, reports and evaluation."""
