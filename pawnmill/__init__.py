"""pawnmill: a PySpark-native engine for board-game corpora and sequence-model evaluation."""
