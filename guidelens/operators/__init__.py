"""DataFrame operators: demultiplexing, alleles, summaries, merging, curation, export."""
