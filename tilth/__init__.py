"""tilth: annotated-text, timed-recording and learner-progress analytics on Spark."""
