"""weftline: analytics over ordered element arrays, written as Spark plans."""
