"""Where rows come from: literal catalogues, Parquet tables and stored JSON."""
