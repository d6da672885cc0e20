from twinsift.cli import main

main()
