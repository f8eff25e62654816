"""Knowledge retrieval, conversation memory and training-corpus preparation on Spark."""
