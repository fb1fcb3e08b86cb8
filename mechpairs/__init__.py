"""DataFrame operators for labelled-pair corpora: build, curate, evaluate."""
