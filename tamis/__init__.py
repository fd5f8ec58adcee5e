"""tamis: consistency analytics over application files, as Spark DataFrame plans."""
