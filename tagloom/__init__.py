"""Sequence labelling on Spark: token tables, tag-history features,
distributed perceptron training, trigram decoding and chunk scoring."""
