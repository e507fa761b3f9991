"""Search, clustering and quantization operators over DataFrames."""
