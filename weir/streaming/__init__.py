"""Streams. There are no operators of their own here: those that are one aggregation (word_count, group_mean,
conditional_means) take a streaming DataFrame as it is and run in complete or update mode."""
