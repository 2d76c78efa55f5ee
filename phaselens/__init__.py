"""Light-field analytics on Spark: frames, volumes and point-spread functions as DataFrames."""
