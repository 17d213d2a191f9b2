"""Where rows come from: streams, tables, built dimensions."""
