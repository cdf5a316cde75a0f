"""DataFrame operators: DAG parsing and corruption, quality control, pass@k, reports, sampling, generation logs."""
