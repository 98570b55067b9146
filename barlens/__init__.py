"""barlens: screening of daily market bars, and text-corpus preparation, as lazy Spark plans."""
