"""helixframe: k-mer and assembly-graph analytics expressed as Spark plans."""
