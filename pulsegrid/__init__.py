"""pulsegrid: DataFrame operators for biosignal recordings, experiment logs and text corpora on Spark."""
