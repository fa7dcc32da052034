"""DataFrame operators: sampling, segments, selection, sequences, duplicates, job state, reports."""
