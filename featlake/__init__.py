"""featlake: feature engineering and prediction blending on PySpark DataFrames."""
