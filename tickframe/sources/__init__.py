"""Where points come from and go to: write requests, the record log, the partitioned store."""
