"""DataFrame in, DataFrame out. Nothing here runs a job except where it says so."""
