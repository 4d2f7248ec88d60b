"""DataFrame operators over the mutation log."""
