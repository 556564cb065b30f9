"""postledger: snapshot synchronisation, scoring and ranking of listings on PySpark."""
