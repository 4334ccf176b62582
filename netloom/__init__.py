"""Network-flow analytics on Spark: packets, flows, features, scores, alerts, reports."""
