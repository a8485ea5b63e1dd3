"""siftmill: cleaning, de-duplicating, classifying and linking large pools of postings and pages on Spark."""
