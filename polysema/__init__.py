"""Word-sense analytics on Spark: similarity graphs, sense induction and disambiguation."""
