"""How a query's input is put together: scopes, token streams, running positions."""
