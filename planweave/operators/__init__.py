"""DataFrame operators, each partitioned by the keys it is given (a scene, a line, a user)."""
