"""highmark: ranks the best moments of long recordings, as Spark plans."""
