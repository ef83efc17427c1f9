"""A Spark library for UTXO-ledger analytics and corpus preparation."""
