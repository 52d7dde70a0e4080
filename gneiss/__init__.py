"""An evidence engine on Spark: declarative operators over DataFrames."""
